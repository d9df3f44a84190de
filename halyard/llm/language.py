"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary of pieces gives every word a lattice of
segmentations. A language is a probability per piece; the probability of a
word is the sum over all its segmentations, by the forward algorithm, and the
score of a text is the product over its words. Training runs the same lattice
forwards and backwards and re-estimates the pieces from expected counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import held, lean

#: Labelled rows of a language that training reads, in expectation.
ROWS_PER_LANGUAGE = 1500
EM_ROUNDS = 2
#: Letters of a word scored at once; longer words are cut.
WORD_LETTERS = 24
#: Distinct words whose scores a task remembers at once.
CACHE_ENTRIES = 200_000
#: Probability of a letter that is no piece, in every language.
UNKNOWN = 1e-7
UNDECIDED = "und"

_LETTERS = r"[^\W\d_]+"
_MARK = "▁"


class Lattice:
    """All pieces of a fixed vocabulary in batches of words."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece as spm

        sp = spm.SentencePieceProcessor(model_file=model_path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        pieces = sorted({p.lower() for p in pieces if 0 < len(p) <= WORD_LETTERS})
        self.size = len(pieces) + 1  # id 0: a letter that is no piece
        self.longest = max(map(len, pieces))
        self.index = {}
        ids = np.arange(1, len(pieces) + 1)
        lengths = np.array([len(p) for p in pieces])
        for n in range(1, self.longest + 1):
            own = np.flatnonzero(lengths == n)
            keys = self.key(np.array([pieces[i] for i in own], dtype=f"U{n}").view(np.uint32).reshape(len(own), n))
            order = np.argsort(keys)
            self.index[n] = (keys[order], ids[own][order])

    @staticmethod
    def key(letters: np.ndarray) -> np.ndarray:
        h = np.full(len(letters), 0x9E3779B97F4A7C15, dtype=np.uint64)
        for i in range(letters.shape[1]):
            h = (h ^ letters[:, i].astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        return h

    def arcs(self, words: list[str]) -> tuple[int, dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Longest word; (end, length) to (words, pieces); lengths. Words get a
        mark in front. Pieces of one end and length meet a word once."""
        marked = np.array([_MARK + w for w in words])
        wide = marked.dtype.itemsize // 4
        letters = marked.view(np.uint32).reshape(len(words), wide)
        lengths = (letters != 0).sum(axis=1)
        found = {}
        for start in range(wide):
            live = np.flatnonzero(lengths > start)
            h = np.full(len(live), 0x9E3779B97F4A7C15, dtype=np.uint64)
            for n in range(1, min(self.longest, wide - start) + 1):
                keep = lengths[live] >= start + n
                live, h = live[keep], h[keep]
                if not len(live):
                    break
                h = (h ^ letters[live, start + n - 1].astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
                h ^= h >> np.uint64(32)
                keys, ids = self.index[n]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1) if len(keys) else None
                hit = keys[at] == h if at is not None else np.zeros(len(live), dtype=bool)
                piece = np.where(hit, ids[at], 0) if at is not None else np.zeros(len(live), dtype=np.int64)
                if n == 1:
                    found[start + 1, 1] = (live, piece)
                elif hit.any():
                    found[start + n, n] = (live[hit], piece[hit])
        return wide, found, lengths

    def score(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language; table: pieces x languages."""
        wide, arcs, lengths = self.arcs(words)
        forward = np.zeros((wide + 1, len(words), table.shape[1]))
        forward[0] = 1
        for end, n in sorted(arcs):
            rows, piece = arcs[end, n]
            forward[end, rows] += forward[end - n, rows] * table[piece]
        return np.log(forward[lengths, np.arange(len(words))])

    def expected(self, words: list[str], weights: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Expected count of each piece over weighted words of one language."""
        wide, arcs, lengths = self.arcs(words)
        forward, backward = np.zeros((wide + 1, len(words))), np.zeros((wide + 1, len(words)))
        forward[0] = 1
        for end, n in sorted(arcs):
            rows, piece = arcs[end, n]
            forward[end, rows] += forward[end - n, rows] * table[piece]
        each = np.arange(len(words))
        backward[lengths, each] = 1
        total = forward[lengths, each]
        counts = np.zeros(self.size)
        for end, n in sorted(arcs, reverse=True):
            rows, piece = arcs[end, n]
            through = table[piece] * backward[end, rows]
            np.add.at(counts, piece, weights[rows] * forward[end - n, rows] * through / total[rows])
            backward[end - n, rows] += through
        return counts


def lattice_of(model_path: str) -> Lattice:
    """One lattice a worker, whatever the number of tasks it runs."""
    return held(Lattice, model_path)


def words_of(text: str) -> list[str]:
    import re

    return [w[i : i + WORD_LETTERS - 1] for w in re.findall(_LETTERS, text.lower()) for i in range(0, len(w), WORD_LETTERS - 1)]


def train(labelled: DataFrame, model_path: str, rows_per_language: int = ROWS_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages in order and log probabilities, pieces x languages.

    labelled: text, lang, and columns that tell rows apart. Reads about
    rows_per_language rows of a language (a documented bound: chosen by a hash
    of the row, all rows if fewer).
    Words are counted and expected counts summed on the executors; the driver
    holds one number per piece and language."""
    row = F.xxhash64(*labelled.columns, F.lit("train"))
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    lattice = lattice_of(model_path)
    table = np.full((lattice.size, max(1, len(langs))), 1.0 / lattice.size)
    if not langs:
        return langs, table
    rate = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, rows_per_language / sizes[k])))])
    chosen = F.shiftrightunsigned(row, 11) / float(1 << 53) < rate[F.col("lang")]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen.setdefault(lang, Counter()).update(words_of(text.as_py()))
            rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
            yield pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "word": [r[1] for r in rows], "n": pa.array([r[2] for r in rows], pa.int64())}, schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))

    counts = labelled.where(chosen).select("lang", "text").mapInArrow(lean(split, keep=True), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    table[0] = UNKNOWN
    for _ in range(EM_ROUNDS):
        now = table

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = lattice_of(model_path)
            total = np.zeros((own.size, len(langs)))
            for batch in batches:
                lang, word, n = (batch.column(i).to_pylist() for i in range(3))
                by: dict[str, list[int]] = {}
                for i, k in enumerate(lang):
                    by.setdefault(k, []).append(i)
                for k, at in by.items():
                    column = langs.index(k)
                    for i in range(0, len(at), 10_000):
                        some = at[i : i + 10_000]
                        total[:, column] += own.expected([word[j] for j in some], np.array([n[j] for j in some], dtype=float), now[:, column])
            piece, column = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(column, pa.int32()), pa.array(total[piece, column])], names=["piece", "lang", "n"])

        sums = counts.mapInArrow(lean(expect, keep=True), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect()
        table = np.full((lattice.size, len(langs)), 0.02)
        for r in sums:
            table[r["piece"], r["lang"]] += r["n"]
        table[0] = 0
        table /= table.sum(axis=0)
        table[0] = UNKNOWN
    counts.unpersist()
    return langs, table


def identify(docs: DataFrame, langs: list[str], table: np.ndarray, model_path: str) -> DataFrame:
    """docs with lang_pred (string) and score (double) appended.

    lang_pred is the language under which the whole text is likeliest (ties:
    first in code-point order), score its posterior under a flat prior. Null
    text, a text without letters, or no language learned: `und`, score 0.
    Other columns pass through, but `text` must be there; columns named
    lang_pred and score are replaced. The table is one number per piece and
    language, shipped with the task."""
    spark = docs.sparkSession
    kept = docs.drop("lang_pred", "score")
    at = kept.columns.index("text")
    shared = spark.sparkContext.broadcast(table)
    schema = kept.schema.jsonValue()
    schema["fields"] += [{"name": "lang_pred", "type": "string", "nullable": True, "metadata": {}}, {"name": "score", "type": "double", "nullable": True, "metadata": {}}]
    from pyspark.sql.types import StructType

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        lattice, probabilities = lattice_of(model_path), shared.value
        find = re.compile(_LETTERS).findall
        cache: dict[str, int] = {}
        scores = np.zeros((CACHE_ENTRIES + 1, len(langs)))
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = [find(x.as_py().lower()) if x.is_valid else [] for x in part.column(at)]
                texts = [t if any(any(map(str.isalpha, w)) for w in t) else [] for t in texts]
                if any(len(w) >= WORD_LETTERS for t in texts for w in t):
                    texts = [[w[i : i + WORD_LETTERS - 1] for w in t for i in range(0, len(w), WORD_LETTERS - 1)] for t in texts]
                new = list({w for t in texts for w in t if w not in cache}) if langs else []
                if len(cache) + len(new) > CACHE_ENTRIES:
                    cache.clear()
                    new = list({w for t in texts for w in t})
                    if len(new) >= len(scores):
                        scores = np.zeros((len(new) + 1, len(langs)))
                base = len(cache)
                for i in range(0, len(new), 10_000):
                    scores[base + i : base + min(len(new), i + 10_000)] = lattice.score(new[i : i + 10_000], probabilities)
                cache.update(zip(new, range(base, base + len(new))))
                names, sure = [], []
                for t in texts:
                    if not t or not langs:
                        names.append(UNDECIDED)
                        sure.append(0.0)
                        continue
                    total = scores[[cache[w] for w in t]].sum(axis=0)
                    best = int(total.argmax())
                    names.append(langs[best])
                    sure.append(float(1 / np.exp(total - total[best]).sum()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(sure, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(lean(predict, keep=True), StructType.fromJson(schema))


def held_out() -> F.Column:
    """Rows that no training reads: crc32 of doc_id as text, divisible by 5
    (a null doc_id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify_documents(docs: DataFrame, model_path: str, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """Learn from the labelled rows of docs that are not held out and predict
    every row: docs with lang_pred and score. Only text reaches a prediction."""
    langs, table = train(docs.where(~held_out()).select("doc_id", "text", "lang"), model_path, rows_per_language)
    return identify(docs, langs, table, model_path)
