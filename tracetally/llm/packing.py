"""Best-fit packing of token sequences, planned over counts of lengths.

Every document becomes token ids and a closing id; only longer ones are cut into pieces of the
sequence size. The plan needs nothing but the number of pieces of each length: best-fit decreasing
puts ranges of equal pieces into ranges of equal sequences, so its size depends on the sequence
size and not on the number of documents. Pieces then take the planned slots by a join on their
rank within their length.

Defined results: null text counts as empty; an empty text is one piece with the closing id only;
rows that repeat an id are packed separately; pieces of equal length are ranked in blocks by id,
piece, start and checksum, so equal rows are interchangeable. An empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scan import numbered
from .common import kept_by_worker, per_row, stored, texts

SIZE = 2048
CLOSING = (0).to_bytes(4, "little")
CACHE = 500_000  # words that are remembered in each of two generations, and as many stems
LONG_WORD = 48  # longer words are encoded anew each time
RANKED = 20_000  # pieces of one length that are numbered together, on average
SPREAD = 10_000  # slots that one planned row expands to at a time
PLAN = "length long, rank_from long, items long, first_sequence long, per_sequence long, first_offset long"


class WordEncoder:
    """Ids of a text, as bytes, from the ids of its words.

    This vocabulary's tokenizer turns white space into single spaces and never joins characters across
    them, so words between spaces or line ends can be encoded one by one and remembered. It also never
    joins ASCII letters with a final point or comma and reads them in lower case, so such words share
    the ids of their letters. Other letters may end in a mark once lower-cased or composed, which
    does join what follows; words with such letters are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.letters = tokenizer.encode_batch_fast, tokenizer.model.tokenize
        self.words: dict[str, bytes] = {}  # as they stand in texts
        self.words_before: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}  # letters, and words of other characters
        self.old: dict[str, bytes] = {}
        self.tails = {c: self._fresh([c])[c] for c in ".,"}

    def _fresh(self, words: list[str]) -> dict[str, bytes]:
        """Lower-case ASCII letters reach the tokenizer's model as they are; all else goes through the whole tokenizer."""
        plain = [w for w in words if w.isascii() and w.isalpha() and w.islower()]
        other = [w for w in words if not (w.isascii() and w.isalpha() and w.islower())]
        out = {w: array("I", [t.id for t in self.letters(w)]).tobytes() for w in plain}
        found = self.encode(other, add_special_tokens=False)
        out.update((w, array("I", e.ids).tobytes()) for w, e in zip(other, found))
        return out

    @staticmethod
    def _stem(word: str) -> tuple[str, str]:
        body, tail = (word[:-1], word[-1]) if word[-1:] in (".", ",") else (word, "")
        return (body.lower(), tail) if body.isascii() and body.isalpha() else (word, "")

    def _ids(self, words: list[str]) -> dict[str, bytes]:
        stems = {w: self._stem(w) for w in words}
        wanted = {s for s, _ in stems.values()}
        known = {s: v for s in wanted if (v := self.young.get(s) or self.old.get(s)) is not None}
        fresh = self._fresh([s for s in wanted if s not in known])
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
        known.update(fresh)
        self.young.update((s, v) for s, v in known.items() if len(s) <= LONG_WORD)
        return {w: known[s] + self.tails[t] if t else known[s] for w, (s, t) in stems.items()}

    def __call__(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        if len(self.words) > CACHE:
            self.words, self.words_before = {}, self.words
        known = self.words
        missing = [w for w in set(words) if w not in known]
        if missing and self.words_before:
            known.update((w, v) for w in missing if (v := self.words_before.get(w)) is not None)
            missing = [w for w in missing if w not in known]
        if not missing:
            return b"".join(map(known.__getitem__, words))
        fresh = self._ids(missing)
        known.update(fresh)
        ids = b"".join(map(known.__getitem__, words))
        for w in [w for w in fresh if len(w) > LONG_WORD]:
            del known[w]
        return ids


def encoder(path: str) -> WordEncoder:
    if path not in kept_by_worker:
        kept_by_worker[path] = WordEncoder(path)
    return kept_by_worker[path]


def token_pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and its ids as bytes if asked for.

    ``tokenizer``: a file that executors can read, or the name of one that ``public_tokenizers`` places.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        path = tokenizer
        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        encode = encoder(path)

        def one(doc_id, text):
            ids = encode(text) + CLOSING
            out = []
            for n, i in enumerate(range(0, len(ids), 4 * size)):
                part = ids[i : i + 4 * size]
                out.append((doc_id, n, i // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
            return out

        return one

    return per_row(docs, make, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts; rows of PLAN.

    A row says: of the pieces of ``length``, the ``items`` from rank ``rank_from`` on go
    ``per_sequence`` at a time into the sequences from ``first_sequence`` on, there from
    ``first_offset``. An item goes to the fullest sequence that still holds it; having taken one, that
    sequence stays the fullest, so it takes all it can before the next one does.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by free tokens: ranges (first sequence, how many)
    made, rows = 0, []
    for length in sorted(counts, reverse=True):
        left, rank, free = counts[length], 0, length
        while left:
            while free <= size and not room[free]:
                free += 1
            if free > size:
                space, first, many = size, made, -(-left // (size // length))
                made += many
            else:
                space = free
                first, many = room[free].pop()
            per = space // length
            for per_one, used in ((per, min(many, left // per)), (left % per, 1)):
                used = min(used, many)
                if not per_one or not used or per_one > left:
                    continue
                rows.append((length, rank, per_one * used, first, per_one, size - space))
                room[space - per_one * length].append((first, used))
                rank, left, first, many = rank + per_one * used, left - per_one * used, first + used, many - used
            if many:
                room[space].append((first, many))
    return rows


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = docs.sparkSession
    pieces = stored(token_pieces(texts(docs, id_col, text_col), tokenizer, size, with_ids))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``size`` rows
    blocks = sum(counts.values()) // RANKED + 1
    ranked = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    ranked = numbered(ranked, ["length"], "block", ["doc_id", "piece", "start", "ids_crc32"], "rank").drop("block")
    planned = spark.createDataFrame(plan(counts, size), PLAN)
    runs = planned.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("items") - 1) / SPREAD)))).repartition("length", "rank_from", "run")
    end = F.least(F.col("items"), (F.col("run") + 1) * SPREAD) - 1
    slots = runs.withColumn("i", F.explode(F.sequence(F.col("run") * SPREAD, end)))
    per = F.col("per_sequence")
    slots = slots.select(
        "length", (F.col("rank_from") + F.col("i")).alias("rank"), (F.col("first_sequence") + F.floor(F.col("i") / per)).alias("sequence_id"),
        (F.col("first_offset") + F.pmod(F.col("i"), per) * F.col("length")).alias("offset"),
    )
    return ranked.join(slots, ["length", "rank"]).select(*pieces.columns, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its token ids as little-endian bytes; ``packed`` must have the ids of its pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most ``size`` pieces
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.expr("aggregate(parts, X'', (a, p) -> a || p.ids)").alias("ids"))
