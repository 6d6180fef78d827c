"""Language identification by cross-parsing entropy.

For each language a generalised suffix automaton of labelled text (bytes, A-Z lowered, runs of ASCII that are no letters
as one kind of blank) gives longest-match lengths: a text is cut greedily into the longest phrases that occur in the
language's text. Phrases times log2 of the training size, divided by the text's length, is the cross-parsing
entropy; the language with the least wins, ties to the smaller name.

Automata become one dense transition table in which a failing step is already resolved: it opens a new phrase
at the root. All blocks of a batch of texts then step through all languages at once (numpy), so the work per byte is a
few array operations. A text is parsed whole, in blocks of `BLOCK` bytes; each block opens a phrase, so a long text has up to one
phrase a block more than the exact parse, in all languages alike.

What is fitted is a bounded sample of labelled rows (allowed by the task): for each language whole texts of rows in
seeded hash order up to `train_bytes` (see `fit`). Prediction uses the text alone.

Defined results: null text, empty text and text without a letter give `und` with score 0; null labels are not
learned; with no labelled row at all every text gives `und`; repeated rows are predicted alike; extra columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._automaton import SuffixAutomaton
from ._text import LOWER, slices, string_buffers
from ._worker import resident

UNKNOWN = "und"
TRAIN_BYTES = 24_000
TRAIN_DOCS = 48
BLOCK = 1024
SEED = 7


class Model:
    def __init__(self, sample: tuple[tuple[str, tuple[str, ...]], ...]) -> None:
        self.langs = [lang for lang, _ in sample]
        letter = np.arange(256) >= 0x80
        letter[0x61:0x7B] = True
        seen = np.unique(np.concatenate([np.zeros(0, np.uint8), *(LOWER[np.frombuffer(t.encode(), np.uint8)] for _, texts in sample for t in texts)]))
        # symbols: 0 blank, 1 bytes of no training text, 2 padding, then the letters' bytes
        self.symbol = np.zeros(256, np.uint8)
        self.symbol[letter] = 1
        own = [b for b in seen if letter[b]]
        for k, b in enumerate(own):
            self.symbol[b] = 3 + k
        self.symbol[0x41:0x5B] = self.symbol[0x61:0x7B]
        self.width = 3 + len(own)
        tables, self.root, self.size, base = [], [], [], 0
        for _, texts in sample:
            sam, total = SuffixAutomaton(), 0
            for t in texts:
                s = self.symbols(np.frombuffer(t.encode(), np.uint8)).tolist()
                sam.add(s)
                total += len(s)
            open_ = len(sam.next)  # one more state: no phrase is open, so any symbol opens one
            table = np.full((open_ + 1, self.width), -1, np.int64)
            for s, edges in enumerate(sam.next):
                for c, to in edges.items():
                    table[s, c] = to
            fresh = np.where(table[0] >= 0, table[0], open_)  # a symbol that the language lacks is a phrase of its own
            value = np.where(table >= 0, (table + base) * self.width * 2, (fresh[None, :] + base) * self.width * 2 + 1)
            value[:, 2] = base * self.width * 2
            tables.append(value.astype(np.int32 if (base + open_ + 1) * self.width < 2**29 else np.int64))
            self.root.append((base + open_) * self.width)
            self.size.append(max(2, total))
            base += open_ + 1
        self.table = np.concatenate([x.ravel() for x in tables]) if tables else np.zeros(0, np.int32)

    def symbols(self, raw: np.ndarray) -> np.ndarray:
        s = self.symbol[raw]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        return s[keep]

    def rates(self, col: pa.Array) -> np.ndarray:
        """Cross-parsing entropy of each text (rows) by each language (columns)."""
        raw, off = string_buffers(col)
        s = self.symbol[raw]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        keep[off[:-1][off[:-1] < len(s)]] = True
        kept = np.concatenate([[0], np.cumsum(keep)])
        s, off = s[keep], kept[off]
        n = np.diff(off)
        blocks = -(-n // BLOCK)
        doc = np.repeat(np.arange(len(n)), blocks)
        within = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        lo = off[:-1][doc] + within * BLOCK
        length = np.minimum(BLOCK, off[1:][doc] - lo)
        order = np.argsort(-length, kind="stable")  # blocks that have ended drop off the end
        lo, length, doc = lo[order], length[order], doc[order]
        active = np.searchsorted(-length, -np.arange(1, BLOCK + 1), side="right")
        k = len(self.langs)
        state = np.repeat(np.asarray(self.root, self.table.dtype)[None, :], len(lo), 0)
        phrases = np.zeros((len(lo), k), np.int32)
        for t in range(int(length[0]) if len(length) else 0):
            m = int(active[t])
            v = self.table[state[:m] + s[lo[:m] + t][:, None]]
            phrases[:m] += v & 1
            state[:m] = v >> 1
        total = np.zeros((len(n), k))
        for j in range(k):
            total[:, j] = np.bincount(doc, phrases[:, j], minlength=len(n))
        return total * np.log2(self.size) / np.maximum(n, 1)[:, None]

    def predict(self, col: pa.Array, known: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(col), np.zeros(len(col))
        r = self.rates(col)
        best = np.argmin(r, 1)
        least = r[np.arange(len(r)), best]
        if len(self.langs) > 1:
            second = np.partition(r, 1, 1)[:, 1]
            score = np.where(second > 0, second / np.maximum(second + least, 1e-12), 0.5)
        else:
            score = np.ones(len(r))
        names = np.asarray(self.langs, object)[best]
        names[~known] = UNKNOWN
        return names.tolist(), np.where(known, score, 0.0)


def _model(sample) -> Model:
    return resident(Model, sample)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_bytes: int = TRAIN_BYTES, train_docs: int = TRAIN_DOCS) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """The bounded sample per language: whole texts in seeded hash order of the id, train_docs at most, as far as they fit.

    A text takes a quarter of train_bytes at most, so that some make up the sample; of a language without such texts the
    shortest of train_docs candidates is learned. Rows without id aren't learned. A threshold on the hash goes first and
    texts are fetched last, so no task holds more than a small multiple of the bounds; memory goes with the number of languages.
    """
    size, h = F.octet_length(text_col), F.xxhash64(F.lit(SEED), id_col)
    fine = labelled.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).rlike("\\p{L}"))
    counts = fine.groupBy(F.col(lang_col).alias("lang"), (size <= train_bytes // 4).alias("short")).count().collect()
    n = {lang: {r.short: r["count"] for r in counts if r.lang == lang} for lang in {r.lang for r in counts}}
    bar = F.lit(-(2**63))
    for lang, own in sorted(n.items()):
        near = min(1.0, 4 * train_docs / own.get(True, own.get(False, 1)))  # four times as many as are taken
        bar = F.when(F.col(lang_col) == lang, F.lit(int(min(2**63 - 1, -(2**63) + near * 2**64)))).otherwise(bar)
    short = F.when(F.col(lang_col).isin(*(k for k, own in n.items() if own.get(True))), size <= train_bytes // 4).otherwise(F.lit(True)) if n else F.lit(True)
    order = Window.partitionBy("lang").orderBy("h", "id", "th")
    top = fine.filter(short & (h <= bar)).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), h.alias("h"), size.alias("b")).withColumn("k", F.row_number().over(order))
    chosen: dict[str, list] = {}
    held: dict[str, int] = {}
    found = sorted(top.filter(F.col("k") <= train_docs).collect(), key=lambda r: (r.lang, r.k))
    for r in found:
        if n[r.lang].get(True) and held.get(r.lang, 0) + r.b <= train_bytes:
            chosen.setdefault(r.lang, []).append((r.lang, r.id, r.th))
            held[r.lang] = held.get(r.lang, 0) + r.b
    for lang in n:
        if not n[lang].get(True) and (own := [r for r in found if r.lang == lang]):
            least = min(own, key=lambda r: (r.b, r.k))
            chosen[lang] = [(lang, least.id, least.th)]
    if not chosen:
        return ()
    schema = T.StructType([T.StructField("__lang", T.StringType()), T.StructField("__id", labelled.schema[id_col].dataType), T.StructField("__th", T.LongType())])
    picked = F.broadcast(labelled.sparkSession.createDataFrame([x for own in chosen.values() for x in own], schema))
    same = (F.col(lang_col) == F.col("__lang")) & (F.col(id_col) == F.col("__id")) & (F.xxhash64(text_col) == F.col("__th"))
    texts = {(r[0], r[1], r[2]): r[3] for r in fine.join(picked, same).groupBy("__lang", "__id", "__th").agg(F.min(text_col)).collect()}
    return tuple((lang, tuple(texts[x] for x in own)) for lang, own in sorted(chosen.items()))


def identify(docs: DataFrame, sample, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All columns plus pred_col and score_col (columns of these names are replaced)."""
    bag = docs.sparkSession.sparkContext.broadcast(sample)
    keep = [c for c in docs.columns if c not in (pred_col, score_col)]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])

    def run(batches):
        own = _model(bag.value)
        for batch in batches:
            for part in slices(batch, text_col):
                known = np.asarray(part.column("__letter").to_pylist(), bool)
                names, score = own.predict(part.column(text_col), known)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score)], names=schema.names)

    letter = F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias("__letter")
    return docs.select(*keep, letter).mapInArrow(run, schema)
