"""Best-fit packing planned on the histogram of lengths.

Documents become token pieces of at most ``limit`` tokens.  Best-fit runs over the counts
of the lengths, not over documents: a plan has at most a few thousand entries whatever the
size of the corpus.  Each entry is a run of slots for one length, and the pieces of that
length take the slots by their rank.

Defined results: null and empty texts are one piece that holds only the end token; repeated
rows are separate documents; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstream.session import cut_lineage

from .bpe import Memory, loaded
from .common import rank_in_groups

LIMIT = 2048
END = 0
#: Distinct words whose tokens a worker process remembers in each of two generations.
REMEMBERED = 700_000
#: Marks that may end a word; characters that Python splits on though the tokenizer's white space lacks them.
MARKS = ".,;:!?&*#$%|"
ODD_SPACES = ("\x1c", "\x1d", "\x1e", "\x1f")


class WordEncoder:
    """Token ids of a text as little-endian 32-bit words.

    The tokenizer never joins characters over white space, so the tokens of a text are
    those of its words, and a word is encoded once per worker process while it is remembered.  It also cuts between letters
    and marks, and lower-cases one character at a time; so a word of letters before one mark
    is put together from the lower-case word and the mark.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._memory = Memory(REMEMBERED)
        self._known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in found]

    @staticmethod
    def _parts(word: str) -> tuple[str, str]:
        core = word.rstrip(MARKS)
        low = core.lower()
        # one letter's lower case depends on its place, and some letters' lower case has a mark of its own
        return (low, word[len(core):]) if core.isalpha() and low.isalpha() and "\u03a3" not in core else (word, "")

    def learn(self, texts: list[str]) -> None:
        """Encodes the new words of a batch of texts in one call; only the batch's words are at hand afterwards."""
        known, new = self._memory.known({w for t in texts for w in t.split()})
        parts = {w: self._parts(w) for w in new}
        found, missing = self._memory.known({p for pair in parts.values() for p in pair if p})
        found |= zip(missing, self._encode(missing), strict=True)
        found[""] = b""
        learned = {w: found[core] + found[mark] for w, (core, mark) in parts.items()}
        self._memory.learn(learned | {m: found[m] for m in missing})
        self._known = known | learned

    def __call__(self, text: str) -> bytes:
        if any(c in text for c in ODD_SPACES):
            return self._encode([text])[0]
        known, words = self._known, text.split()
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            self.learn([text])
            return b"".join([self._known[w] for w in words])


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           limit: int = LIMIT, keep_ids: bool = False) -> DataFrame:
    """Token pieces: id, piece, start, length, ids_crc32, and the ids as bytes if asked for."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = loaded(tokenizer_path, WordEncoder), struct.pack("<I", END)
        for batch in batches:
            rows = []
            encode.learn([t for t in batch.iloc[:, 1] if t])
            for key, text in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                ids = (encode(text) if text else b"") + end
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at:at + 4 * limit]
                    rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part), part)[:len(names)])
            yield pd.DataFrame(rows, columns=names).astype({id_col: batch.iloc[:, 0].dtype})

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(id_col, text_col).mapInPandas(cut, schema)


def plan_best_fit(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of slots: (length, first rank, end rank, first sequence, pieces a sequence, offset).

    Longest first; each piece goes to the open sequence with the least room that holds it.
    Sequences filled alike stay one run, so work and result follow the number of lengths.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    plan, fresh = [], 0

    def leave(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in room:
                room[space] = []
                insort(rooms, space)
            room[space].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                space = rooms[at]
                first, n = room[space].pop()
                if not room[space]:
                    del room[space], rooms[at]
            else:
                space, first, n = limit, fresh, max(1, left // (limit // length))
                fresh += n
            each = min(space // length, left)
            used = min(n, left // each)
            plan.append((length, rank, rank + used * each, first, each, limit - space))
            leave(space, first + used, n - used)
            leave(space - each * length, first, used)
            rank, left = rank + used * each, left - used * each
    return plan


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         limit: int = LIMIT, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents with sequence_id and their offset in it.

    The histogram that comes to the driver has at most ``limit`` rows, and the plan that is
    broadcast has a few runs per length.
    """
    spark = docs.sparkSession
    cut = cut_lineage(pieces(docs, tokenizer_path, id_col, text_col, limit, keep_ids))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.createDataFrame(
        plan_best_fit(counts, limit),
        "_length long, _from long, _to long, _sequence long, _each long, _offset long")
    ranked = rank_in_groups(cut, "length", [id_col, "piece"], F.xxhash64(id_col, "piece"))
    nth = F.col("rank") - F.col("_from")
    own = (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to"))
    return ranked.join(F.broadcast(slots), own).select(
        *cut.columns,
        (F.col("_sequence") + F.floor(nth / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(nth, F.col("_each")) * F.col("length")).cast("long").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence as bytes, from pieces packed with ``keep_ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length"))
