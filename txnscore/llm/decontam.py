"""Documents that carry benchmark items, found with a BM25 index of the items.

The items are indexed (inverted lists with block maxima); every passage of every
document is a query. An item's scores are divided by the score it has for itself,
so one threshold serves all items: the share of an item's weight that a passage
holds. Block-max WAND finds all items at or above it; a candidate counts if both the
question and the answer of the item overlap with the text around the passage.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnscore.llm import shared
from txnscore.session import fresh_path, materialize

CHUNK = 1 << 21
BLOCK = 8
# Words: runs of ASCII letters and digits and of bytes from 0x80 on.
GAP = np.ones(256, bool)
GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Rules:
    """``least``: share of an item's BM25 weight in a passage; ``overlap``: share of the 3-word runs of question and of answer."""

    least: float = 0.5
    overlap: float = 0.6
    passage: int = 64
    k1: float = 1.2
    b: float = 0.75
    block_bytes: int = 8 << 20


def tokens(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").translate(bytes(shared.ASCII_LOWER)))


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """Up to the last question mark, else all but the last sentence; the rest. One sentence is halved."""
    head, mark, rest = text.strip().rpartition("?")
    if not (mark and tokens(head) and tokens(rest)):
        head, rest = re.fullmatch(r"(.*[.!?\n])?\s*(\S.*)?", text.strip(), re.S).groups(default="") if text.strip() else ("", "")
        if not tokens(rest) and head:
            # The text ends with a full stop: its last sentence is the answer.
            head, _, rest = head.strip()[:-1].rpartition(". ")
    if tokens(head) and tokens(rest):
        return tokens(head), tokens(rest)
    words = tokens(text)
    return words[: len(words) // 2], words[len(words) // 2 :]


def runs(words: list[bytes], n: int = 3) -> set[tuple[bytes, ...]]:
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(n))))


class Index:
    """Inverted lists of a block of items: item numbers and impacts, with the maximum of every ``BLOCK`` entries.

    ``known`` has what BM25 takes from all items, whatever block they are in: their number,
    their mean length and the items of each word here. Without it the block is all there is.
    """

    def __init__(self, items: list[tuple[int, str]], rules: Rules, known: tuple[int, float, dict[bytes, int]] | None = None):
        self.rules = rules
        texts = [(i, t, tokens(t)) for i, t in items]
        texts = [x for x in texts if x[2]]
        self.ids = [i for i, _, _ in texts]
        self.parts = [tuple(runs(p) for p in question_and_answer(t)) for _, t, _ in texts]
        bags = [Counter(w) for _, _, w in texts]
        total, mean, df = known or (len(bags), sum(len(w) for _, _, w in texts) / max(1, len(texts)), Counter(w for bag in bags for w in bag))
        lists: dict[bytes, list[tuple[int, float]]] = {w: [] for w in df}
        for n, (bag, (_, _, words)) in enumerate(zip(bags, texts)):
            norm = rules.k1 * (1 - rules.b + rules.b * len(words) / mean)
            impact = {w: np.log1p((total - df[w] + 0.5) / (df[w] + 0.5)) * c * (rules.k1 + 1) / (c + norm) for w, c in bag.items()}
            whole = sum(impact.values())
            for w, x in impact.items():
                lists[w].append((n, x / whole))
        self.lists = {w: ([n for n, _ in x], [y for _, y in x], [max(y for _, y in x[k : k + BLOCK]) for k in range(0, len(x), BLOCK)]) for w, x in lists.items()}
        # Words so frequent that no item gathers half the threshold from them alone: a
        # passage needs the other half from the rest, the essential words.
        gathered, essential = np.zeros(len(bags)), []
        for w in sorted(lists, key=lambda w: (-df[w], w)):
            add = np.zeros(len(bags))
            for n, x in lists[w]:
                add[n] = x
            if essential or (gathered + add).max() > rules.least / 2:
                essential.append(w)
            else:
                gathered += add
        # What each item needs from its essential words, for a passage to reach the threshold.
        self.needed = rules.least - gathered
        joined = b" ".join(essential)
        size = np.array([len(w) for w in essential], np.int64)
        start = np.cumsum(size + 1) - size - 1
        keys = shared.word_hashes(np.frombuffer(joined, np.uint8), start, start + size) if essential else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        essential = [essential[k] for k in order]
        # The essential words' lists, one after another, in the order of the hashes.
        self.first = np.cumsum([0, *(len(self.lists[w][0]) for w in essential)])
        self.items = np.array([n for w in essential for n in self.lists[w][0]], np.int64)
        self.impact = np.array([x for w in essential for x in self.lists[w][1]])
        self.span = max([rules.passage, *(len(w) for _, _, w in texts)])

    def search(self, words: set[bytes], least: float) -> list[tuple[int, float]]:
        """All items with at least that share, by block-max WAND."""
        cursors = [[ids[0], 0, ids, impacts, blocks, max(blocks)] for ids, impacts, blocks in (self.lists[w] for w in words if w in self.lists)]
        least -= 1e-9
        found = []

        def advance(c, item):
            """To the first entry at or after ``item``, whole blocks at a time."""
            at, ids = c[1], c[2]
            while at < len(ids) and ids[min(at | (BLOCK - 1), len(ids) - 1)] < item:
                at = (at | (BLOCK - 1)) + 1
            while at < len(ids) and ids[at] < item:
                at += 1
            c[1] = at
            c[0] = ids[at] if at < len(ids) else -1

        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += c[5]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, beyond = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else len(self.ids)
            for c in cursors[: pivot + 1]:
                at, ids = c[1] // BLOCK, c[2]
                while at < len(c[4]) and ids[min(at * BLOCK + BLOCK - 1, len(ids) - 1)] < item:
                    at += 1
                if at < len(c[4]):
                    bound += c[4][at]
                    beyond = min(beyond, ids[min(at * BLOCK + BLOCK - 1, len(ids) - 1)] + 1)
            if bound < least:
                item = max(item + 1, beyond)
            elif cursors[0][0] == item:
                score = sum(c[3][c[1]] for c in cursors[: pivot + 1])
                if score >= least:
                    found.append((item, score))
                item += 1
            for c in cursors[: pivot + 1]:
                if c[0] < item:
                    advance(c, item)
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def _able(self, hits, words, rows, count, half, first, last) -> np.ndarray:
        """Passages in which some item gathers what it needs from essential words.

        WAND's bound for all passages at once: the scores over the essential lists, with
        all that the other words of an item could add. The rest need no search.
        """
        row = np.searchsorted(rows, hits, "right") - 1
        begin = np.cumsum(count) - count
        nth = (hits - rows[row]) // half
        size = self.first[words + 1] - self.first[words]
        ends = np.cumsum(size)
        entry = np.repeat(self.first[words] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        keys, weights = [], []
        for back in range(3):
            passage = begin[row] + nth - back
            fits = (nth - back >= 0) & (nth - back < count[row])
            passage = np.where(fits, passage, 0)
            fits &= (first[passage] <= hits) & (hits < last[passage])
            keep = np.repeat(fits, size)
            keys.append((np.repeat(passage, size) * len(self.ids) + self.items[entry])[keep])
            weights.append(self.impact[entry][keep])
        key, weight = np.concatenate(keys), np.concatenate(weights)
        able = np.zeros(len(first), bool)
        # An item whose other words suffice could be anywhere.
        if (self.needed <= 1e-6).any():
            able[:] = True
        elif len(key):
            order = np.argsort(key, kind="stable")
            head = np.flatnonzero(np.diff(key[order], prepend=-1))
            total, key = np.add.reduceat(weight[order], head), key[order][head]
            able[key[total >= self.needed[key % len(self.ids)] - 1e-6] // len(self.ids)] = True
        return able

    def matches(self, data: np.ndarray, offsets: np.ndarray):
        """(row, item number, passages, score, question overlap, answer overlap) of all verified items."""
        for a, b in shared.chunks(offsets, CHUNK):
            lo = offsets[a]
            low = shared.ASCII_LOWER[data[lo : offsets[b]]]
            start, end, rows = shared.words_of(low, offsets[a : b + 1] - lo, GAP)
            if not len(start) or not len(self.keys):
                continue
            hashes = shared.word_hashes(low, start, end)
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            # Passages: one from every half span on, to the end of the document.
            half = max(1, self.span // 2)
            count = 1 + np.maximum(0, -(-(np.diff(rows) - self.span) // half))
            count[np.diff(rows) == 0] = 0
            ends = np.cumsum(count)
            row = np.repeat(np.arange(b - a), count)
            first = rows[row] + half * (np.arange(ends[-1]) - np.repeat(ends - count, count))
            last = np.minimum(first + self.span, rows[row + 1])
            hits = np.flatnonzero(self.keys[at] == hashes)
            able = self._able(hits, at[hits], rows, count, half, first, last)
            seen: dict[tuple[int, int], list] = {}
            for r, x, y in zip(row[able].tolist(), first[able].tolist(), last[able].tolist()):
                words = [low[p:q].tobytes() for p, q in zip(start[x:y].tolist(), end[x:y].tolist())]
                around = None
                for item, score in self.search(set(words), self.rules.least):
                    if around is None:
                        p, q = max(rows[r], x - self.span), min(rows[r + 1], y + self.span)
                        around = runs([low[s:e].tobytes() for s, e in zip(start[p:q].tolist(), end[p:q].tolist())])
                        around |= {t[:n] for t in around for n in (1, 2)} | {t[n:] for t in around for n in (1, 2)}
                    question, answer = (len(part & around) / max(1, len(part)) for part in self.parts[item])
                    if question >= self.rules.overlap and answer >= self.rules.overlap:
                        best = seen.setdefault((r, item), [0, 0.0, 0.0, 0.0])
                        best[0] += 1
                        best[1:] = max(best[1:], [score, question, answer])
            for (r, item), best in sorted(seen.items()):
                yield r + a, item, *best


_WORDS = pa.schema([("i", pa.int64()), ("t", pa.string()), ("n", pa.int64()), ("words", pa.list_(pa.string()))])


def build(benchmark: DataFrame, rules: Rules, id_col: str = "item_id", text_col: str = "text") -> "Blocks":
    """The indexes of all test items, one for each block, built in tasks and stored.

    Blocks hold items of like length (a passage is as long as its block's longest item) and
    about ``rules.block_bytes`` of text. BM25's statistics are those of all items. Rows
    without words match nothing; repeated items are kept once. The driver sees the number
    of items, their mean length and the numbers of the blocks.
    """
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL").distinct()

    def split(batches):
        for batch in batches:
            given = [(r["i"], r["t"], tokens(r["t"])) for r in batch.to_pylist()]
            found = [{"i": i, "t": t, "n": len(w), "words": sorted({x.decode("utf-8", "surrogatepass") for x in w})} for i, t, w in given if w]
            yield pa.RecordBatch.from_pylist(found, _WORDS)

    items = materialize(rows.mapInArrow(split, "i long, t string, n long, words array<string>"), "items")
    total, mean = items.agg(F.count("*"), F.avg("n")).first()
    path = fresh_path(benchmark.sparkSession, "item-indexes")
    if not total:
        return Blocks(path, [])
    each = items.select("i", "t", F.explode("words").alias("word"))
    df = each.groupBy("word").agg(F.count("*").alias("df"))
    uses = each.join(df, "word").groupBy("i", "t").agg(F.collect_list(F.struct("word", "df")).alias("uses"))
    length = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / rules.passage))).cast("int")
    # One row per length class, some dozens at most.
    shares = items.groupBy(length.alias("length")).agg(F.ceil(F.sum(F.octet_length("t")) / rules.block_bytes).alias("blocks"))
    dealt = items.withColumn("length", length).join(F.broadcast(shares), "length")
    dealt = dealt.withColumn("block", F.col("length").cast("long") * (1 << 32) + F.pmod(F.xxhash64("i", "t"), F.col("blocks")))
    dealt = dealt.select("i", "t", "block").join(uses, [dealt.i.eqNullSafe(uses.i), dealt.t == uses.t]).select(dealt.i, dealt.t, "block", "uses")

    def index(key, table):
        rows = sorted(((r["i"], r["t"], r["uses"]) for r in table.to_pylist()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        known = {u["word"].encode("utf-8", "surrogatepass"): u["df"] for _, _, uses in rows for u in uses}
        made = Index([(i, t) for i, t, _ in rows], rules, (total, mean, known))
        return pa.table({"block": [key[0].as_py()], "data": [pickle.dumps(made)]}, pa.schema([("block", pa.int64()), ("data", pa.binary())]))

    dealt.groupBy("block").applyInArrow(index, "block long, data binary").write.partitionBy("block").parquet(path)
    numbers = benchmark.sparkSession.read.parquet(path).select("block").distinct().collect()
    return Blocks(path, sorted(r["block"] for r in numbers))


# Bytes of stored indexes that a worker keeps loaded; beyond them blocks are read again for every batch.
KEPT_BYTES = 32 << 20
_kept: dict[str, tuple[int, Index]] = {}


@dataclass(frozen=True)
class Blocks:
    """Where the indexes are and their numbers; a task has one block beyond ``KEPT_BYTES`` at a time."""

    path: str
    numbers: list[int]

    def _load(self, block: int) -> Index:
        folder = f"{self.path}/block={block}"
        if folder not in _kept:
            fs, base = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
            files = [f.path for f in fs.get_file_info(pafs.FileSelector(base)) if f.path.endswith(".parquet")]
            data = [x for f in files for x in pq.read_table(f, columns=["data"], filesystem=fs, partitioning=None)["data"].to_pylist()]
            made = pickle.loads(data[0])
            for other in [k for k in _kept if not k.startswith(self.path + "/")]:
                del _kept[other]
            if sum(n for n, _ in _kept.values()) + len(data[0]) > KEPT_BYTES:
                return made
            _kept[folder] = (len(data[0]), made)
        return _kept[folder][1]

    def matches(self, data: np.ndarray, offsets: np.ndarray):
        """(row, item id, passages, score, question overlap, answer overlap) of all verified items."""
        for block in self.numbers:
            index = self._load(block)
            for r, item, *figures in index.matches(data, offsets):
                yield r, index.ids[item], *figures


RESULT = "doc_id long, item_id long, n_passages long, score double, question_overlap double, answer_overlap double"


_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_passages", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
_NAMES = _ARROW.names


def contaminated(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every document row and benchmark item it carries, with the best passage's figures.

    Passages cover whole texts: ``rules.passage`` words (or the longest item's), each half
    overlapping the next. NULL and empty texts carry nothing; an empty benchmark gives no rows.
    """
    blocks = build(benchmark, rules)

    @shared.frugal
    def run(batches):
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            rows = [(ids[r], *x) for r, *x in blocks.matches(*shared.byte_column(batch["text"]))]
            yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, x)) for x in rows], _ARROW)

    return shared.text_rows(docs, id_col, text_col).mapInArrow(run, RESULT)


def keep_clean(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that carry no benchmark item, with all their columns; NULL texts stay."""
    blocks = build(benchmark, rules)

    @shared.frugal
    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            clean = np.ones(batch.num_rows, bool)
            clean[[r for r, *_ in blocks.matches(*shared.byte_column(column))]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
