"""Positional inverted index and the searches that read it.

Documents are dealt over shards, words over buckets. A row holds one word's documents of one part of a shard with
their lengths and the word's positions; the table is partitioned by bucket and sorted by the word's
hash, so a search reads only the buckets of its words, and skips row groups there. Phrases are matched
by intersecting position lists. Scores are added up shard by shard in arrays, and every shard keeps its
best candidates of each query: no row per document and query exists before that cut.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sizing import chunks_for, shared_folder

SHARD_DOCS = 20_000  # documents of a shard on average: what one task holds of the index, for a chunk's words
PART_DOCS = 5_000  # documents whose rows one task sorts and writes, on average
BUCKETS = 16
META = -1  # bucket of the rows that describe shards
SLICED = 1 << 12  # a word's documents in one row at most
POSTING = "shard int, token string, ids array<string>, lengths array<bigint>, tfs array<bigint>, positions array<array<int>>, n_docs bigint, total_length bigint"
HIT = "shard int, phrase int, ids array<string>, lengths array<bigint>, tfs array<bigint>"


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")


def _code(token: Column) -> Column:
    return F.xxhash64(token)


def bucket_of(token: Column) -> Column:
    return F.pmod(_code(token), F.lit(BUCKETS)).cast("int")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of every shard and word of a batch of documents (shard, id, n_tokens, tokens), documents in order of their ids; a row without a word has a shard's totals."""
    names = ["shard", "token", "ids", "lengths", "tfs", "positions", "n_docs", "total_length"]
    kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32()))]
    for whole in batches:
        for start in range(0, whole.num_rows, SLICED):
            batch = whole.slice(start, SLICED).sort_by("id")
            tokens = batch.column("tokens")
            sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
            words = tokens.flatten().dictionary_encode()
            here, of = np.unique(batch.column("shard").to_numpy(), return_inverse=True)
            total = np.zeros(len(here), np.int64)
            np.add.at(total, of, pc.fill_null(batch.column("n_tokens"), 0).to_numpy(zero_copy_only=False))
            sums = [pa.array(here), *[pa.nulls(len(here), k) for k in kinds], pa.array(np.bincount(of, minlength=len(here)).astype(np.int64)), pa.array(total)]
            yield pa.RecordBatch.from_arrays(sums, names=names)
            if not len(words):
                continue
            doc = np.repeat(np.arange(batch.num_rows), sizes)
            pos = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            shard, word = batch.column("shard").to_numpy()[doc], words.indices.to_numpy()
            order = np.lexsort((word, shard))  # stable: documents and positions stay in order
            doc, pos, shard, word = (x[order] for x in (doc, pos, shard, word))
            new = np.ones(len(doc), bool)
            new[1:] = (shard[1:] != shard[:-1]) | (word[1:] != word[:-1])
            rows = np.flatnonzero(new)
            new[1:] |= doc[1:] != doc[:-1]
            held = np.flatnonzero(new)  # a document of a word
            inner = np.append(held, len(doc)).astype(np.int32)
            outer = pa.array(np.append(np.searchsorted(held, rows), len(held)).astype(np.int32))
            at = pa.array(doc[held])
            lists = [batch.column("id").take(at), batch.column("n_tokens").take(at), pa.array(np.diff(inner).astype(np.int64))]
            lists.append(pa.ListArray.from_arrays(pa.array(inner), pa.array(pos.astype(np.int32))))
            columns = [pa.array(shard[rows]), words.dictionary.take(pa.array(word[rows])), *[pa.ListArray.from_arrays(outer, x) for x in lists]]
            columns += [pa.array(np.diff(np.append(np.searchsorted(held, rows), len(held))).astype(np.int64)), pa.nulls(len(rows), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def build_inverted(lexical: DataFrame, shard_docs: int = SHARD_DOCS, part_docs: int = PART_DOCS) -> DataFrame:
    """bucket, code, token, shard, ids, lengths, tfs, positions and rows of totals of every shard; not yet written.

    One exchange, by shard and part of a shard: documents, words and words' rows then stay where they are, and a task
    sorts the rows of a part. Rows are made batch by batch of a part's documents, so no row per occurrence of a word exists.
    """
    spark = lexical.sparkSession
    documents = lexical.count()
    shards = shards_for(documents, spark, shard_docs)
    parts = chunks_for(documents, part_docs * shards)
    part = F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(parts)).cast("int")
    dealt = lexical.select(_shard(shards).alias("shard"), part.alias("part"), "id", "n_tokens", "tokens").repartition(shards * parts, "shard", "part")
    rows = dealt.select("shard", "id", F.col("n_tokens").cast("long").alias("n_tokens"), "tokens").mapInArrow(_postings, POSTING)
    own = F.col("token").isNotNull()
    return rows.select(
        F.when(own, bucket_of(F.col("token"))).otherwise(META).alias("bucket"), F.when(own, _code(F.col("token"))).otherwise(shards).alias("code"),
        F.coalesce("token", F.lit("")).alias("token"), "shard", "ids", "lengths", "tfs", "positions", "n_docs", "total_length",
    )


def write_inverted(index: DataFrame) -> DataFrame:
    """The index as a table in the shared folder, partitioned by bucket; every shard's rows are written where they are, sorted by the words' hash."""
    spark = index.sparkSession
    path = f"{shared_folder(spark)}/inverted-{uuid.uuid4().hex}"
    index.sortWithinPartitions("bucket", "code", "shard").write.partitionBy("bucket").parquet(path)
    order = ["code", "token", "shard", "ids", "lengths", "tfs", "positions", "n_docs", "total_length", "bucket"]
    return spark.read.schema(index.select(*order).schema).parquet(path)


def is_inverted(table: DataFrame) -> bool:
    return "positions" in table.columns


def read_words(index: DataFrame, words: DataFrame, buckets: list[int]) -> DataFrame:
    """The index rows of some words (token and what else is known of them); only their buckets are opened."""
    return index.filter(F.col("bucket").isin(buckets)).join(F.broadcast(words), "token")


def starts(positions: list[list[int]]) -> list[int]:
    """Where a phrase begins in a document, from the positions of its words in order."""
    found = np.asarray(positions[0])
    for k, p in enumerate(positions[1:], 1):
        found = found[np.isin(found + k, np.asarray(p), assume_unique=True)]
    return found.tolist()


def _grouped(table: pa.Table) -> dict[str, tuple[list, list, list]]:
    """Documents, lengths and positions of every word of a shard; documents in order of their ids."""
    out: dict[str, tuple[list, list, list]] = {}
    for token, ids, lengths, positions in zip(*[table.column(c) for c in ("token", "ids", "lengths", "positions")]):
        held = out.setdefault(token.as_py(), ([], [], []))
        for have, new in zip(held, (ids, lengths, positions)):
            have.append(new.values)
    return out


def _matcher(phrases: list[tuple[int, list[str]]]) -> Callable[[pa.Table], pa.Table]:
    """Phrases of a shard by intersecting documents, rarest word first, then positions."""

    def match(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        words = _grouped(table)
        places: dict[str, dict[str, tuple[int, list[int]]]] = {}

        def documents(word: str) -> dict[str, tuple[int, list[int]]]:
            if word not in places:
                ids, lengths, positions = (pa.concat_arrays(x).to_pylist() for x in words[word])
                places[word] = dict(zip(ids, zip(lengths, positions)))
            return places[word]

        out: list[tuple] = []
        for number, phrase in phrases:
            if any(w not in words for w in phrase):
                continue
            maps = [documents(w) for w in phrase]
            rarest = min(maps, key=len)
            hits = [(i, rarest[i][0], n) for i in rarest if all(i in m for m in maps) and (n := len(starts([m[i][1] for m in maps])))]
            if hits:
                ids, lengths, tfs = zip(*hits)
                out.append((shard, number, pa.array(ids), pa.array(lengths, pa.int64()), pa.array(tfs, pa.int64())))
        types = [pa.string(), pa.int64(), pa.int64()]
        lists = []
        for k, t in enumerate(types, 2):
            offsets = np.cumsum([0, *[len(r[k]) for r in out]]).astype(np.int32)
            flat = pa.concat_arrays([r[k].cast(t) for r in out]) if out else pa.array([], t)
            lists.append(pa.ListArray.from_arrays(pa.array(offsets), flat))
        columns = [pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), *lists]
        return pa.Table.from_arrays(columns, names=["shard", "phrase", "ids", "lengths", "tfs"])

    return match


def phrase_hits(index: DataFrame, phrases: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(shard, phrase number, ids, lengths, tfs) of the phrases (phrase, words) of a bounded chunk, and the numbers.

    The shards are dealt over as many partitions as there are, so a task's part does not grow with the index.
    """
    spark = index.sparkSession
    rows = phrases.collect()  # a chunk's phrases
    numbers = {r["phrase"]: k for k, r in enumerate(rows)}
    named = [(k, list(r["words"])) for k, r in enumerate(rows)]

    def buckets(words: DataFrame) -> list[int]:
        return [r["b"] for r in words.select(bucket_of(F.col("token")).alias("b")).distinct().collect()]  # at most BUCKETS

    alone = spark.createDataFrame([(w[0], k) for k, w in named if len(w) == 1], "token string, phrase int")
    hits = read_words(index, alone, buckets(alone)).select("shard", "phrase", "ids", "lengths", "tfs")
    several = [(k, w) for k, w in named if len(w) > 1]
    if several:  # only these read positions
        words = spark.createDataFrame(sorted({(x,) for _, w in several for x in w}), "token string")
        touched = read_words(index, words, buckets(words)).select("shard", "token", "ids", "lengths", "positions")
        touched = touched.repartition(totals(index)[2], "shard")
        hits = hits.unionByName(touched.groupBy("shard").applyInArrow(_matcher(several), HIT))
    return hits, numbers


def shards_for(documents: int, spark: SparkSession, shard_docs: int = SHARD_DOCS) -> int:
    return max(chunks_for(documents, shard_docs), spark.sparkContext.defaultParallelism)


class Phrases:
    """Phrases as codes of their words, to be found in many documents at a time."""

    def __init__(self, phrases: list[list[str]]):
        self.words = pa.array(sorted({w for p in phrases for w in p}), pa.string())
        code = {w: k for k, w in enumerate(self.words.to_pylist())}
        self.alone = np.full(len(code), -1, np.int64)  # the phrase that is this word
        several = []
        for k, p in enumerate(phrases):
            if len(p) == 1:
                self.alone[code[p[0]]] = k
            elif p:
                several.append((code[p[0]] * len(code) + code[p[1]], k, [code[w] for w in p]))
        several.sort()
        self.begins, self.number = (np.array([x[i] for x in several], np.int64) for i in (0, 1))  # first two words; phrase
        self.size = np.array([len(c) for _, _, c in several], np.int64)
        self.codes = np.array([w for _, _, c in several for w in c], np.int64)
        self.at = np.cumsum(self.size) - self.size

    def find(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, phrase, how often it starts there) for documents given as lists of words."""
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        flat = tokens.flatten().dictionary_encode()
        known = pc.fill_null(pc.index_in(flat.dictionary, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        word = np.append(known, -1)[pc.fill_null(flat.indices, len(known)).to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        phrase = np.where(word >= 0, np.append(self.alone, -1)[word], -1)
        found = [(doc[phrase >= 0], phrase[phrase >= 0])]
        if len(self.begins) and len(word) > 1:
            first = np.flatnonzero((word[:-1] >= 0) & (word[1:] >= 0) & (doc[:-1] == doc[1:]))
            pair = word[first] * len(self.words) + word[first + 1]
            lo, hi = np.searchsorted(self.begins, pair), np.searchsorted(self.begins, pair, side="right")
            start, which = np.repeat(first, hi - lo), np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
            inside = start + self.size[which] <= ends[doc[start]]
            start, which, k = start[inside], which[inside], 2
            while len(start):
                done = self.size[which] == k
                found.append((doc[start[done]], self.number[which[done]]))
                start, which = start[~done], which[~done]
                same = word[start + k] == self.codes[self.at[which] + k]
                start, which, k = start[same], which[same], k + 1
        doc, phrase = (np.concatenate(x) for x in zip(*found))
        many = max(1, len(self.alone) + len(self.number))
        key, times = np.unique(doc * many + phrase, return_counts=True)
        return key // many, key % many, times.astype(np.int64)


def _numbered(phrases: DataFrame) -> tuple[Phrases, dict[str, int]]:
    rows = phrases.select("phrase", "words").collect()  # a chunk's phrases
    return Phrases([list(r["words"]) for r in rows]), {r["phrase"]: k for k, r in enumerate(rows)}


def scan_phrases(lexical: DataFrame, phrases: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(id, n_tokens, phrase number, tf) of the phrases (phrase, words) of a bounded chunk, and the numbers.

    A scan of the documents, a bounded number of them at a time: nothing is shuffled or held.
    """
    finder, numbers = _numbered(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICED):
                batch = whole.slice(start, SLICED)
                doc, phrase, times = finder.find(batch.column("tokens"))
                at = pa.array(doc)
                columns = [batch.column("id").take(at), batch.column("n_tokens").take(at), pa.array(phrase.astype(np.int32)), pa.array(times)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "phrase", "tf"])

    read = lexical.select("id", F.col("n_tokens").cast("long").alias("n_tokens"), "tokens")
    return read.mapInArrow(run, "id string, n_tokens long, phrase int, tf long"), numbers


def scan_hits(lexical: DataFrame, phrases: DataFrame, shards: int) -> tuple[DataFrame, dict[str, int]]:
    """What ``phrase_hits`` gives, from a scan of documents without an index."""
    finder, numbers = _numbered(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICED):
                batch = whole.slice(start, SLICED)
                doc, phrase, times = finder.find(batch.column("tokens"))
                shard = batch.column("shard").to_numpy()[doc]
                order = np.lexsort((phrase, shard))
                doc, phrase, times, shard = (x[order] for x in (doc, phrase, times, shard))
                new = np.ones(len(doc), bool)
                new[1:] = (shard[1:] != shard[:-1]) | (phrase[1:] != phrase[:-1])
                rows, at = np.flatnonzero(new), pa.array(doc)
                outer = pa.array(np.append(rows, len(doc)).astype(np.int32))
                lists = [batch.column("id").take(at), batch.column("n_tokens").take(at), pa.array(times)]
                columns = [pa.array(shard[rows]), pa.array(phrase[rows].astype(np.int32)), *[pa.ListArray.from_arrays(outer, x) for x in lists]]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "phrase", "ids", "lengths", "tfs"])

    read = lexical.select(_shard(shards).alias("shard"), "id", F.col("n_tokens").cast("long").alias("n_tokens"), "tokens")
    return read.mapInArrow(run, HIT), numbers


def totals(index: DataFrame) -> tuple[int, int, int]:
    """Documents, tokens and shards of an index."""
    r = index.filter(F.col("bucket") == META).agg(F.sum("n_docs"), F.sum("total_length"), F.max("code")).first()
    return int(r[0] or 0), int(r[1] or 0), int(r[2] or 1)


SCORED = "query_id string, id string, revision string, score double, candidate_limit bigint"


def best_of_shards(hits: DataFrame, seen: DataFrame, queries: list[dict], weigh: Callable, scale: float) -> DataFrame:
    """Every shard's best candidates of each query (query_id, phrases with times, policy, candidate_limit).

    seen: shard, id, revision, policies. ``weigh(phrase, tf, length)`` gives whole-number weights.
    """

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "id", "revision", "score", "candidate_limit"]
        right = right.sort_by("id")
        ids, revisions = right.column("id").combine_chunks(), right.column("revision").combine_chunks()
        out: list[tuple] = []
        if len(left) and len(right):
            listed = left.column("ids").combine_chunks()
            sizes = pc.list_value_length(listed).to_numpy(zero_copy_only=False)
            doc = pc.index_in(listed.flatten(), value_set=ids).to_numpy(zero_copy_only=False)
            phrase = np.repeat(left.column("phrase").to_numpy(), sizes)
            lengths, tfs = (left.column(c).combine_chunks().flatten().to_numpy() for c in ("lengths", "tfs"))
            here = ~np.isnan(doc) if doc.dtype.kind == "f" else np.ones(len(doc), bool)
            doc, phrase = doc[here].astype(np.int64), phrase[here]
            weight = weigh(phrase, tfs[here], lengths[here])
            order = np.argsort(phrase, kind="stable")
            doc, phrase, weight = doc[order], phrase[order], weight[order]
            policies = right.column("policies").combine_chunks()
            owner = np.repeat(np.arange(len(right)), pc.list_value_length(policies).to_numpy(zero_copy_only=False))
            policy = policies.flatten().to_numpy()
            by_policy = np.argsort(policy, kind="stable")
            policy, owner = policy[by_policy], owner[by_policy]
            for q in queries:
                may = owner[slice(*np.searchsorted(policy, [q["policy"], q["policy"] + 1]))]
                if not len(may):
                    continue
                numbers, times = q["phrases"]
                a, b = np.searchsorted(phrase, numbers), np.searchsorted(phrase, numbers, side="right")
                total = np.zeros(len(right), np.int64)
                for s, e, n in zip(a, b, times):
                    total[doc[s:e]] += weight[s:e] * n  # a document stands once under a phrase
                sums = total[may]
                may, sums = may[sums > 0], sums[sums > 0]
                limit = q["candidate_limit"]
                if len(sums) > limit:
                    least = np.partition(sums, len(sums) - limit)[len(sums) - limit]
                    may, sums = may[sums >= least], sums[sums >= least]
                best = np.lexsort((may, -sums))[:limit]
                out.append((q["query_id"], may[best], sums[best] / scale, limit))
        at = np.concatenate([m for _, m, _, _ in out]) if out else np.zeros(0, np.int64)
        counts = [len(m) for _, m, _, _ in out]
        columns = [
            pa.array(np.repeat(np.array([q for q, *_ in out], object), counts), pa.string()), ids.take(pa.array(at)).cast(pa.string()), revisions.take(pa.array(at)).cast(pa.string()),
            pa.array(np.concatenate([s for _, _, s, _ in out]) if out else [], pa.float64()), pa.array(np.repeat(np.array([n for *_, n in out], np.int64), counts), pa.int64()),
        ]
        return pa.Table.from_arrays(columns, names=names)

    return hits.groupBy("shard").cogroup(seen.groupBy("shard")).applyInArrow(score, SCORED)


def shards_of(items: DataFrame, shards: int) -> DataFrame:
    return items.withColumn("shard", _shard(shards))
